"""Each operator against brute force, with the awkward cases of the shared corpus."""

import hashlib
import math
import random
import unicodedata
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kursbuch.llm import bitslice_topk, bpe, exact_dedup, mixing, ngram_join, quality, queries, secrets, token_count, url_filter, warc
from kursbuch.llm.automata import Automaton, classes, follow

from .conftest import make_docs

SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# 1 mixing
def test_mix_meets_targets(docs, corpus, no_docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus)
    sizes = Counter()
    for i, t, s in corpus:
        sizes[s] += len(WORDS.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    ratio = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # deal, cap, deal the rest again
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        open_ratio = sum(ratio[s] for s in order if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else left * ratio[s] / open_ratio for s in order}
        over = {s for s in order if s not in capped and target[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + r["target"])
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) and r["taken"] >= r["epochs"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in order)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(no_docs).count() == 0


def test_selection_follows_the_keys(docs):
    by = defaultdict(list)
    for r in mixing.mix(docs).collect():
        by[r["source"]].append(r)
    for rows in by.values():
        rest = rows[0]["target"] - rows[0]["epochs"] * rows[0]["source_size"]
        rows.sort(key=lambda r: (r["sample_key"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"]))
        upto = 0
        for r in rows:
            upto += r["size"]
            extra = r["taken"] - r["epochs"] * r["size"]
            assert extra == (r["size"] if rest > 0 and 2 * upto - r["size"] <= 2 * rest else 0)


def test_weights_and_drawing(docs):
    heavy = mixing.mix(docs, weight=F.when(F.col("doc_id") % 2 == 0, 100.0).otherwise(0.01), ratios=(1,), share=0.4).collect()
    drawn = [r["doc_id"] % 2 == 0 for r in heavy if r["doc_id"] is not None and r["taken"] > r["epochs"] * r["size"]]
    assert sum(drawn) > 0.75 * len(drawn) > 0
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns and drawn.count() > 0


def test_repeated_rows_are_taken_one_by_one(spark):
    """Two hundred rows with one id and size: as many of them as the target holds, in the plan and drawn."""
    rows = [(1, "one two three four five six seven eight nine ten", "a")] * 200 + [(2 + i, "w " * 7, "b") for i in range(30)]
    rows += [(500, "a b c", "a"), (500, "d e f", "a"), (None, "x y", "a"), (None, "x y", "a")]
    df = make_docs(spark, rows)
    for share in (0.3, 0.45, 1.1):
        plan = mixing.mix(df, share=share).collect()
        drawn = Counter(r["source"] for r in mixing.draw(df, share=share).collect() for _ in WORDS.findall(r["text"]))
        for source in "ab":
            mine = [r for r in plan if r["source"] == source]
            taken = sum(r["taken"] for r in mine)
            assert abs(taken - mine[0]["target"]) <= 5 and drawn[source] == taken, (share, source)


@pytest.mark.parametrize("weight", [1e-6, 0.006, 1.0, 1e6, 1e300])
def test_bins_of_any_weight_are_small(spark, weight):
    rows = spark.range(20_000).select(mixing.exponential_key(F.col("id"), F.lit(weight), 7).alias("key"))
    rows = rows.withColumn("bin", mixing.key_bin(F.col("key")))
    bins = rows.groupBy("bin").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("bin").collect()
    assert max(b["n"] for b in bins) < 20_000 / 100 and 0 <= bins[0]["bin"] and bins[-1]["bin"] < mixing.BINS**2
    assert all(a["hi"] < b["lo"] for a, b in zip(bins, bins[1:]))


# 2 secrets
def test_base_spans_by_the_letter():
    text = "Password: 'abcdefghijkl' token=short secret: token: abcdefghijklmnop AKIAABCDEFGHIJKLMN AKIA12 0123456789abcdef0 PASSWD=ſecretsecret"
    want = []
    for k, (name, p, flags) in enumerate(
        [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0), ("hex", r"[0-9a-f]+", 0)]
    ):
        for m in re.finditer(p, text, flags):
            if len(m[2] if name == "assign" else m[0]) >= (12, 18, 16)[k]:
                want.append((m.start(), k, m.end()))
    assert [s[:3] for s in secrets.base_spans(text)] == sorted(want)
    assert [k for _, k, _ in sorted(want)] == [0, 1, 2]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="AKIZ09af-= :\"'tokens", max_size=80))
def test_hex_and_access_rules(text):
    access = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    hexes = [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    got = secrets.base_spans(text)
    assert [(a, b) for a, k, b, _ in got if k == 1] == access and [(a, b) for a, k, b, _ in got if k == 2] == hexes


def test_automata_tell_formats_apart():
    rnd = random.Random(3)
    keys = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(16, 22))) for _ in range(200)]
    model = secrets.learn({(0, "dl"): keys[:150]}, Counter(map(classes, words[:150])))
    assert sum(secrets.is_credential(model, k) for k in keys[150:]) >= 40
    assert not any(secrets.is_credential(model, w) for w in [*words[150:], "mail7.example.com", "2024-01-01T00:00:00Z"])
    assert Automaton(keys).states < 200


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab0Z-", min_size=1, max_size=12), min_size=1, max_size=60))
def test_no_string_leaves_the_automaton_it_made(strings):
    a = Automaton(strings)
    assert all(None not in a.path(classes(s)) for s in strings)
    assert all(sum(np.exp(p) for p, _ in steps.values()) <= 1 + 1e-9 for steps in a.table)


def test_planted_credentials_of_every_format(spark):
    """Loose credentials in formats that the rules label elsewhere: precision and recall of 0.9 or more."""
    from .conftest import make_docs

    rnd = random.Random(9)
    key = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    formats = [(20, mixed), (40, "0123456789ABCDEF"), (32, mixed + "+/"), (24, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")]
    said = [(i, f'token = "{key(*formats[i % 4])}"', "s1") for i in range(160)]
    loose = [(1000 + i, f"look: {key(*formats[i % 4])} ok", "s1") for i in range(40)]
    parts = [key(rnd.randint(2, 4), "aeioulnrstdg") for _ in range(60)]
    say = lambda: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6))) for _ in range(60))
    plain = [(2000 + i, f"{say()} mail{i % 9}.example.com {i}.10.{i % 200}.7 WHOLEWORDINCAPITALS Some-Name-{i} 2024-05-{i % 28 + 1:02d}T00:00", "s2") for i in range(200)]
    got = {r["doc_id"]: r["n_learnt"] for r in secrets.scan(make_docs(spark, said + loose + plain)).collect()}
    right, wrong = sum(got[i] for i, _, _ in loose), sum(got[i] for i, _, _ in plain)
    assert right >= 0.9 * len(loose) and right >= 0.9 * (right + wrong), (right, wrong)


def test_scan_finds_what_the_rules_miss(spark, corpus, no_docs):
    from .conftest import make_docs

    rnd = random.Random(4)
    key = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = [*corpus, *((1000 + i, f'say token = "{key()}" and more', "s1") for i in range(60)), (2000, f"loose {key().upper().replace('A', 'b')} here", "s1")]
    rows += [(3000 + i, " ".join("".join(rnd.choice(["tion", "hea", "ber", "sch", "en", "the"]) for _ in range(5)) for _ in range(60)), "s1") for i in range(40)]
    got = {r["doc_id"]: r for r in secrets.scan(make_docs(spark, rows)).collect()}
    assert len(got) == len({r[0] for r in rows})
    empty = hashlib.sha256(b"").hexdigest()
    assert got[220]["spans"] == got[221]["spans"] == "" and got[220]["base_sha256"] == empty and got[5]["n_learnt"] == 0
    assert got[1003]["n_assign"] == 1 and got[1003]["n_hex"] == 1 and got[1003]["spans"].split(",")[0] == "assign:4:53"
    assert got[2000]["n_learnt"] == 1 and got[2000]["spans"] == "learnt:6:46"
    assert got[1003]["base_sha256"] == hashlib.sha256(got[1003]["spans"].encode()).hexdigest()
    assert secrets.scan(no_docs).count() == 0


def test_every_run_is_a_candidate(spark):
    """From 12 characters on, with and without digits, and wherever it stands in a long text."""
    from .conftest import make_docs

    rnd = random.Random(6)
    key = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    text = 'pwd: "Xk29fjQ81mZp" abcdefghijk token=abcdefghijklmnop ---------------- 123456789012'
    assert [c[2] for c in secrets.candidates(text, secrets.base_spans(text))] == ["Xk29fjQ81mZp", "-" * 16, "123456789012"]
    labelled = [(i, f'secret = "{key(12, mixed)}"', "s1") for i in range(300)]
    words = [(1000 + i, " ".join([key(rnd.randint(12, 18), "aeioulnrst") for _ in range(20)] + [f"report-2024-{rnd.randint(100000, 999999)}"]), "s1") for i in range(60)]
    words += [(1100 + i, " ".join(key(rnd.randint(12, 18), "aeioulnrst") for _ in range(60)), "s1") for i in range(60)]
    loose = [(2000 + i, f'pwd: "{key(12, mixed)}"', "s2") for i in range(40)]
    bare = [(3000 + i, f'pwd: "{key(12, mixed[:52])}"', "s2") for i in range(40)]
    got = {r["doc_id"]: r["n_learnt"] for r in secrets.scan(make_docs(spark, labelled + words + loose + bare)).collect()}
    assert sum(got[r[0]] for r in loose) >= 20 and sum(got[r[0]] for r in bare) >= 1
    assert sum(got[r[0]] for r in words) <= 60 * 21 // 50


def test_automata_count_every_credential_and_token(spark):
    """All of 900 credentials of one format and of 6,000 other tokens are in the counts, and in the thresholds."""
    from .conftest import make_docs

    rnd = random.Random(8)
    key = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    keys = [key(20, "abcdefghij0123456789") for _ in range(900)]
    tokens = [key(rnd.randint(12, 24), "aeinrstABC-") for _ in range(6000)]
    found = secrets.spans_of(make_docs(spark, [(i, f'token = "{k}"', "s") for i, k in enumerate(keys)] + [(1000 + i, t, "s") for i, t in enumerate(tokens)]))
    for m in secrets.fit(found):
        a, least, odds = m["formats"][0, "dl"]
        assert a.passes[0] >= a.ends[0] and sum(a.ends) == 900
        own = sorted(a.score(k) for k in keys)
        assert least <= own[int(secrets.MISS * 900)] < least + 2 * secrets.STEP
        assert 0.9 * len(tokens) <= sum(m["others"].ends) <= len(tokens) and odds == secrets.odds_of(6000, 900) == secrets.ODDS
    assert secrets.odds_of(10**6, 10) > 11


def test_long_tokens_make_no_chain_of_states(spark, monkeypatch):
    """Copies of a long token are counted whole, but their places beyond DEPTH do not all come to the driver."""
    rnd = random.Random(2)
    long = "".join(rnd.choice("dhlHu") for _ in range(50_000))
    strings = spark.createDataFrame([("0|", long, 3), ("0|", "d" * 40, 2), ("1|", "h" * 16, 300)], "model string, s string, n long")
    sizes, of_tree = [], Automaton.of_tree
    monkeypatch.setattr(Automaton, "of_tree", lambda tree: sizes.append(len(tree)) or of_tree(tree))
    got = secrets.infer(strings)
    assert max(sizes) <= 300 and sum(got["0|"].ends) == 5 and sum(map(sum, (by.values() for by in got["0|"].by))) == 3 * 50_000 + 80
    assert got["1|"].likelihood("h" * 16) > got["1|"].likelihood("h" * 15) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab0Z-", min_size=1, max_size=12), min_size=1, max_size=60))
def test_a_counted_tree_holds_every_string(strings):
    """Prefixes that two strings pass make the states; the counts of the steps are those of all strings."""
    tree, steps = {}, Counter()
    for s in map(classes, strings):
        node = 0
        for c in [*s, ""]:
            tree.setdefault(node, Counter())[c] += 1
            node = follow(node, c) if c else node
    a = Automaton.of_tree({node: by for node, by in tree.items() if by.total() >= 2})
    for s in map(classes, strings):
        at = 0
        for c in s:
            steps[at, c] += 1
            at = a.to[at].get(c, at)
        steps[at, ""] += 1
    a.weigh(steps)
    assert sum(a.ends) == len(strings) and all(None not in a.path(classes(s)) for s in strings)
    assert all(sum(np.exp(p) for p, _ in table.values()) + np.exp(stop) <= 1 + 1e-9 for table, stop in zip(a.table, a.stop, strict=True))


# 3 byte-level BPE
@pytest.fixture(scope="module")
def byte_bpe():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BPE), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n\t'sétx1!²½\x1c\x85\xa0中🙂", max_size=60)))
def test_encode_as_the_library(text):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(BPE, public_tokenizers.PATTERN).machine.ranks, special_tokens={})
    c = bpe.codec(BPE, public_tokenizers.PATTERN)
    ids = c.encode(text)
    assert ids == enc.encode_ordinary(text) and c.decode(ids) == text


def test_transducer_with_and_without_states(byte_bpe, monkeypatch):
    words = ["antidisestablishmentarianism", "aaaaaaaaaaaaaaaaa", "zzzzqx", "ÄÖÜß" * 5, "x" * 3000]
    monkeypatch.setattr(bpe, "STATES", 3)
    few = bpe.Transducer(bpe.read_ranks(BPE))
    monkeypatch.setattr(bpe, "STATES", 10**6)
    many = bpe.Transducer(bpe.read_ranks(BPE))
    for w in words:
        want = byte_bpe.encode_ordinary(w)
        assert few.encode(w.encode()) == want == many.encode(w.encode()) == many.encode(w.encode())


def test_streaming_decode_at_any_cut():
    c = bpe.codec(BPE, public_tokenizers.PATTERN)
    ids = c.encode("naïve 🙂 中文 text")
    d = bpe.StreamDecoder(c.machine.bytes_of)
    assert "".join(d.feed([i]) for i in ids) + d.finish() == "naïve 🙂 中文 text"
    half = bpe.StreamDecoder(c.machine.bytes_of)
    assert half.feed(c.encode("🙂")[:1]) == "" and half.finish() == "\ufffd"


def test_bpe_digests_and_round_trip(docs, corpus, byte_bpe, no_docs):
    got = bpe.digests(docs, BPE, public_tokenizers.PATTERN).collect()
    want = []
    for i, t, _ in corpus:
        ids = byte_bpe.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    back = bpe.decode(bpe.encode(docs, BPE, public_tokenizers.PATTERN), BPE, public_tokenizers.PATTERN)
    assert sorted(str((r["doc_id"], r["text"])) for r in back.collect()) == sorted(str((i, t or "")) for i, t, _ in corpus)
    assert bpe.digests(no_docs, BPE, public_tokenizers.PATTERN).count() == 0


# 4 exact dedup
def test_digest_groups(docs, corpus, no_docs):
    groups = defaultdict(list)
    for i, t, _ in corpus:
        groups[SPACES.sub(" ", t or "")].append(i)
    want = []
    for t, ids in groups.items():
        keep = min((x for x in ids if x is not None), default=None)
        spare = ids.count(keep) - 1
        for i in ids:
            kept = i == keep and not (spare and (spare := spare - 1) >= 0)
            want.append(str((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in exact_dedup.digest_groups(docs).collect()) == sorted(want)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.digest_groups(no_docs).count() == 0 and exact_dedup.drop_copies(no_docs).count() == 0


# 5 top-k
def brute_top(rows, queries, k):
    out = []
    good = [(i, np.floor(256 * np.asarray(v, np.float64)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, w in good:
        if q in queries:
            s = sorted((-int(v @ w), i) for i, v in good if i != q and len(v) == len(w))[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("inf")] + [0.0] * 11), (404, [0.0] * 12), (405, [-1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = bitslice_topk.top_k(df, df.filter("vec_id % 50 = 0"), k=5).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, {r[0] for r in rows if r[0] % 50 == 0}, 5)
    assert bitslice_topk.top_k(df.limit(0), df.limit(0)).count() == 0
    two = df.filter("vec_id in (0, 1, 2)")
    assert bitslice_topk.top_k(two, two.filter("vec_id = 0")).count() == 2


def test_top_k_of_large_components(spark):
    """Nothing finite is left out, and scores are exact at any size."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(150 + i, (rng.normal(size=6) * 2.0**e).tolist()) for i, e in enumerate((13, 19, 20, 22, 27, 40, 300, 1015))]
    rows += [(200, [2.0**20] + [0.0] * 5), (201, [1.7e308] * 6), (202, [-1.7e308] * 6), (203, [2.0**20, 1.0] + [0.0] * 4), (204, [5e-324] * 6)]
    rows += [(210, None), (211, [None] * 6), (212, [float("nan")] * 6), (213, [float("inf")] + [0.0] * 5), (214, [float("-inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in bitslice_topk.top_k(df, df, k=7).collect())
    good = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, w in good:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, v in good if i != q)[:7]
        want += [(q, n + 1, i, -x if -(2**63) <= -x < 2**63 else None) for n, (x, i) in enumerate(best)]
    assert got == sorted(want, key=lambda r: r[:2])


@pytest.mark.parametrize("slices", [1, 3, 7, 12])
def test_bit_slices_any_quantisation(slices):
    rng = np.random.default_rng(slices)
    values = rng.integers(-500, 500, (200, 9))
    values[50:60] = values[0]
    index = bitslice_topk.BitSlicedIndex(values, slices)
    for q in [*values[:20], np.zeros(9, np.int64), -values[3]]:
        rows, score = index.top(q, 5)
        assert sorted(score)[-5:] == sorted(values @ q)[-5:] and (score == values[rows] @ q).all()


# 6 token counts
def test_token_counts(docs, corpus, no_docs):
    tok = Tokenizer.from_file(WORD_BPE)
    extra = [(5000, "<|endoftext|>Hello<|startoftext|> <|endoftext|", "s1")]
    from .conftest import make_docs

    both = docs.unionByName(make_docs(docs.sparkSession, extra))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.token_counts(both, WORD_BPE).collect())
    n = {t: len(tok.encode(t, add_special_tokens=False).ids) for t in {t or "" for _, t, _ in [*corpus, *extra]}}
    assert got == sorted((str(i), len((t or "").encode()), n[t or ""], n[t or ""] > 2048) for i, t, _ in [*corpus, *extra])
    assert token_count.token_counts(no_docs, WORD_BPE).count() == 0


def test_automata_hold_whole_strings_and_their_ends():
    """Rests kept as tails give the counts of the whole tree, at any length; a likelihood counts the end."""
    rnd = random.Random(11)
    strings = ["".join(rnd.choice("hdlu") for _ in range(rnd.choice((3, 20, 5000)))) for _ in range(40)] * 2
    a = Automaton(Counter(strings))
    for s in strings:
        assert None not in list(a.path(s))
    fixed = Automaton(Counter({"h" * 16: 300, "d" * 16: 300}))
    assert fixed.likelihood("h" * 16) > fixed.likelihood("h" * 15) + 1
    assert fixed.likelihood("h" * 16) > fixed.likelihood("h" * 17) + 1
    model = secrets.learn({(1, "u"): ["AKIA" + "".join(rnd.choices("BCDEFGHIJKLMNOPQRSTUVWXYZ", k=16)) for _ in range(200)]}, Counter(map(classes, ["internationalisation", "extraordinarily"] * 50)))
    assert not secrets.is_credential(model, "INTERNATIONALISATION")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab AZ\n'sétx1!²½ÀΣ中\u0301\xa0aaa", max_size=40), max_size=6))
def test_counts_as_the_library(texts):
    tok = Tokenizer.from_file(WORD_BPE) if not hasattr(test_counts_as_the_library, "tok") else test_counts_as_the_library.tok
    test_counts_as_the_library.tok = tok
    assert token_count.counter(WORD_BPE).count(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_every_character_as_the_library():
    """Case, classes and order of marks, also of characters that only one side's tables know."""
    rnd = random.Random(3)
    chars = [chr(i) for i in range(0x20000) if not (0x3400 <= i < 0xA000 or 0xAC00 <= i < 0xE000)]
    marks = [c for c in chars if unicodedata.combining(c) or unicodedata.decomposition(c)]
    texts = [f"a{c}1{c}!{c} b{c}\u0307" for c in chars]
    texts += ["q" + "".join(rnd.choices(marks, k=3)) + unicodedata.normalize("NFD", rnd.choice(marks)) for _ in range(10_000)]
    library = Tokenizer.from_file(WORD_BPE)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_count.Counter(WORD_BPE).count(texts) == want


def test_long_pieces_as_short_ones(monkeypatch):
    """Rounds over arrays of places and rounds over whole pieces give the same counts, and the library's."""
    rnd = random.Random(7)
    pieces = ["".join(rnd.choice(of) for _ in range(n)) for n in (1, 2, 3, 60, 900) for of in ("ab", "etaoinshrdlu", "中文字漢éß") for _ in range(6)] + ["a" * 777, "ab" * 300]
    c = token_count.Counter(WORD_BPE)
    rounds = c.merge([p.encode() for p in pieces]).tolist()
    assert rounds == [c.merge_long(p.encode()) for p in pieces]
    library = Tokenizer.from_file(WORD_BPE)
    monkeypatch.setattr(token_count, "LONG", 10)
    for p in pieces:
        assert token_count.Counter(WORD_BPE).count([p]) == [len(library.encode(p, add_special_tokens=False).ids)]


# 7 URL filter
def test_url_rules(spark):
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/", "block"), ("b.net/x", "allow"), ("org", "block")]
    urls = [None, "", "no scheme", "http://", "https://COM/en/", "http://a.example.com/en/77?x=/en/", "http://xexample.com/en/7", "http://example.com/en/8#/", "ftp://a.b.net/x", "x://net", "y://net?q/", "http://deep.sub.org/any", "http://ÉX.com/en/é", "http://example.com/EN/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(7, urls[7]), (None, urls[5])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    want = []
    for i, u in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
        best = max(fit, default=(0, None, "allow"))
        want.append(str((i, host, path, best[1], best[2])))
    listed = spark.createDataFrame(rules, "rule string, verdict string")
    assert sorted(str(tuple(r)) for r in url_filter.judge(df, listed).collect()) == sorted(want)
    assert url_filter.judge(df.limit(0), listed).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, listed.limit(0)).collect()} == {"allow"}


def test_url_query_by_its_contract(spark, tmp_path):
    """Every rule's own word, the longer rule inside a shorter one, and a host that no rule fits."""
    want = {
        "http://com/en/": ("com/en/", "block"),
        "http://example.com/en/6": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"),
        "http://www.example.net/de/7": ("net/de/", "allow"),
        "http://www.example.net/de/8": ("example.net/de/8", "block"),
        "http://example.org/es/1": ("org/es/", "block"),
        "http://example.org/en/1": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op7_url_filter(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    filt = url_filter.build_bloom(keys, "key", bits_per_key=12)
    test = url_filter.might_contain(spark, filt)
    both = keys.select("key", F.lit(1).alias("listed")).union(spark.range(5000).select(F.concat(F.lit("other"), "id"), F.lit(0)))
    got = both.select("listed", test(F.array(F.xxhash64("key")))[0].cast("int").alias("hit")).groupBy("listed").agg(F.sum("hit").alias("n")).collect()
    n = {r["listed"]: r["n"] for r in got}
    assert n[1] == 5000 and n[0] < 500
    assert url_filter.build_bloom(keys, "key", max_bytes=64) is None


# 8 quality
def test_quality_held_out(spark, no_docs):
    from .conftest import make_docs

    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(5, 60))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "%%%" if bad and k % 2 else w for k, w in enumerate(words)), "s1"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(900, None, "s1"), (901, "", "s1")]
    labels += [(3, 1, 0), (902, 1, 0), (None, 1, 0), (4, None, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make_docs(spark, rows)
    got = {r["doc_id"]: r for r in quality.classify(docs, known).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert got[900]["score"] == got[901]["score"]
    held = [i for i in range(600) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i % 5 != 0) for i in held) > 0.95 * len(held)
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and kept.filter("doc_id % 5 <> 0 and doc_id < 600").count() > 450
    assert quality.classify(no_docs, known).count() == 0
    blind = quality.classify(docs, known.limit(0)).collect()
    assert {r["score"] for r in blind} == {0.5}


# 9 WARC
def test_warc_round_trip_and_lookup(spark, tmp_path, monkeypatch):
    html = ["<p>é</p>", None, "", "<p>same</p>", "<p>same</p>", "x" * 200_000, "a\r\n\r\nb", "<p>same</p>"]
    rows = [(i, f"http://h{i % 3}.example.com/p{i % 4}?q", h) for i, h in enumerate(html)] + [(3, None, "<p>same</p>"), (7, "http://h1.example.com/p3?q", "<p>same</p>"), (None, "u", "lonely")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("largest", F.lit("clash"))
    folder = f"file://{tmp_path}/w"
    directory = warc.write_archive(df, folder, 0)
    back = warc.read_archive(spark, folder, directory, with_payload=True).collect()
    assert len(back) == len(rows)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", -1))
    for r in back:
        size = {(i, u): h for i, u, h in rows}[r["page_id"], r["url"]] or ""
        top = largest.get(size, r["page_id"])
        assert r["payload_bytes"] == len(size.encode()) and r["payload_digest"] == warc.sha1_base32(size.encode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == top else ("revisit", top))
        assert r["payload"] == (size if r["record_type"] == "response" else None)
    ask = lambda *urls: sorted(r["page_id"] for r in warc.find(spark, folder, directory, spark.createDataFrame([(warc.url_key(u),) for u in urls], "url_key string")).collect())
    assert ask("http://h1.example.com/p3?q") == [7, 7] and ask("http://nowhere/") == []
    assert ask("http://h1.example.com/p3?q", "http://h0.example.com/p0?q", "http://zz/") == [0, 7, 7]
    import gzip
    import pathlib

    raw = b"".join(gzip.decompress(f.read_bytes()) for f in pathlib.Path(f"{tmp_path}/w").glob("*.warc.gz"))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and raw.count(b"WARC-Refers-To: ") == raw.count(b"WARC-Profile: ") == raw.count(b"WARC-Type: revisit") > 0
    alone = warc.read_archive(spark, folder + "2", warc.write_archive(df, folder + "2", 1000)).collect()
    assert {r["record_type"] for r in alone} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)  # a url's captures over several blocks
    many = spark.createDataFrame([(i, f"http://h/{i % 3 // 2}", f"text {i % 50}") for i in range(300)], "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in warc.round_trip(many).collect()) == list(range(300))


# 10 n-gram join
def brute_components(corpus, n, num, den):
    sets = []
    for _, t, _ in corpus:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(corpus)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(corpus)):
        for b in range(a):
            if corpus[a][0] is not None and corpus[b][0] is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(corpus):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)) if i is not None else None) for k, (i, _, _) in enumerate(corpus)]


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80), (2, 50)])
def test_components(docs, corpus, n, num):
    got = ngram_join.similar_classes(docs, n, num, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, brute_components(corpus, n, num, 100)))


def test_blocks_of_hot_runs(docs, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_RUN", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rnd = random.Random(8)
    base = [str(i) for i in range(60)]
    chain = []
    for i in range(40):  # a long chain of small steps: its ends are far apart
        base[rnd.randrange(60)] = f"new{i}"
        chain.append((3000 + i, " ".join(base), "s1"))
    from .conftest import make_docs

    rows = [*corpus, *chain]
    got = ngram_join.similar_classes(make_docs(docs.sparkSession, rows), 2, 80, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, brute_components(rows, 2, 80, 100)))


def test_keep_first(docs, corpus, no_docs):
    kept = ngram_join.keep_first(docs, 5, 80, 100)
    want = [i for i, _, c in brute_components(corpus, 5, 80, 100) if i is None or c == i]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, want)) and kept.columns == docs.columns
    assert ngram_join.similar_classes(no_docs).count() == 0


def test_keep_first_tells_rows_of_one_id_apart(spark, no_docs):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
    rows = [(1, long + "end", "s"), (2, long + "end!", "s"), (2, "something else that resembles nothing at all here", "s"), (2, long + "end!", "t"), (3, "other words " * 4, "s")]
    rows += [(2, None, "s"), (2, "", "s"), (None, long + "end", "s"), (4, long + "end", "s"), (4, long + "end?", "s")]
    kept = ngram_join.keep_first(make_docs(spark, rows), 5, 80, 100)
    want = [rows[0], rows[2], *rows[4:8]]
    assert sorted(str((r["doc_id"], r["text"], r["source"])) for r in kept.collect()) == sorted(map(str, want))
    assert ngram_join.keep_first(no_docs).count() == 0 and ngram_join.keep_first(no_docs).columns == no_docs.columns


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.sampled_from([(85, 100), (80, 100), (60, 100)]))
def test_similar_sets_share_their_quota(size, seed, ratio):
    num, den = ratio
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(1, 2**63, size + 200).astype(np.uint64))
    rng.shuffle(base)
    a = set(base[:size].tolist())
    b = set(a)
    for x in base[size:].tolist():
        c = set(b)
        if rng.random() < 0.5 and len(c) > 1:
            c.discard(next(iter(c & a), None))
        else:
            c.add(x)
        if den * len(a & c) < num * len(a | c):
            break
        b = c
    sets = [np.unique(np.array(sorted(s), np.uint64)) for s in (a, b)]
    sig, of = ngram_join.signatures(sets, num, den)
    common = len(set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()))
    assert common >= min(ngram_join.quota(len(s), num, den) for s in sets)


def test_runs_across_batches():
    import pyarrow as pa

    sig = np.repeat(np.arange(40), 7).astype(np.int64)
    node = np.tile(np.array([1, 2, 2, 5, 6, 7, 9]), 40).astype(np.int64)
    size = np.full(280, 10, np.int32)
    whole = pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(size)], ["sig", "node", "size"])
    read = lambda step: sorted(
        str(r) for b in ngram_join._run_members((whole.slice(i, step) for i in range(0, 280, step)), 85, 100) for r in b.to_pylist()
    )
    assert read(280) == read(1) == read(5) == read(13) and len(read(280)) == 240
