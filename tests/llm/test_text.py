"""Encoders, filters, scans, classifiers and the mix against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd_rows import ODD, got
from tokenizers import Tokenizer

from copresence.llm import language_id, mixing, quality_rules, queries, secret_scan, token_store, tree_bpe, url_filter

SF = "/root/testdata/sf0.001"
BITS = ["'", "s", "r", "e", " ", "  ", "\n", "\t", "x", "é", "1", "ſ", "\u0301", "!", ",", "\u2003", "ll", "'re", "'ve", "\x1c", "\x85", "😀", "\r\n", "ñ", "٣", "漢", "A", "É", "Σ", "İ",
        "<|endoftext|>", "½", "²", "µ", "ÿ", "×", "\x0b", "\x00", "\u200b"]


def scraps(seed, n, most=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- byte-level BPE

@pytest.fixture(scope="module")
def words():
    return tree_bpe.vocabulary(public_tokenizers.path(queries.BYTE_RANKS), public_tokenizers.PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 7, 40])
def test_tree_matches(words, leaf):
    for text in scraps(leaf, 800):
        assert tree_bpe.tree_matches(words.matches, text, leaf) == words._any(text)


def test_join_is_associative(words):
    """Any bracketing of the pieces gives the matches of the whole, and empty pieces change nothing."""
    rnd, find = random.Random(4), words._any
    for text in scraps(9, 300, 40):
        cuts = sorted(rnd.randint(0, len(text)) for _ in range(4))
        pieces = [find(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        while len(pieces) > 1:
            i = rnd.randrange(len(pieces) - 1)
            pieces[i:i + 2] = [tree_bpe.join(find, pieces[i], pieces[i + 1])]
        assert pieces[0] == find(text)


def test_long_run_across_the_border(words):
    for text in (" " * 5000 + "x", "a" * 6000, "ab " * 2000 + "\n" * 4000 + "'ll", "!" * 4097 + " 1" * 2000):
        assert tree_bpe.tree_matches(words.matches, text, 16) == words._any(text)


def tiktoken_of(words):
    import tiktoken
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def byte_runs(seed, n):
    """Letters, syllables, blanks, emoji and noise without a break: matches of every length."""
    rng = random.Random(seed)
    sets = ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "eéèàüß", "漢字", "😀🏽", "0123456789", "the and ing tion er", " "]
    return ["".join(rng.choices(rng.choice(sets), k=rng.randint(1, 90))) for _ in range(n)]


@pytest.mark.parametrize("leaf", [1, 3, 8])
def test_tokens_of_matches(words, leaf):
    """Every match, token reduction by halves beside the library, whole-match tokens aside."""
    library = tiktoken_of(words)
    for text in byte_runs(leaf, 700):
        data = text.encode()
        tokens = tree_bpe.tree_tokens(words.ranks, data, leaf)
        assert b"".join(tokens) == data and list(tokens) == tree_bpe.merged(words.ranks, data)
    for text in byte_runs(leaf + 50, 700):
        assert [i for m in words._any(text) for i in words.ids(m)] == library.encode_ordinary(text)


def test_joins_are_associative(words):
    rng = random.Random(4)
    ranks = words.ranks
    for text in byte_runs(9, 150):
        data = text.encode()
        cuts = sorted(rng.sample(range(len(data) + 1), min(4, len(data) + 1)))
        pieces = [tuple(tree_bpe.merged(ranks, data[a:b])) for a, b in zip([0, *cuts], [*cuts, len(data)])]
        while len(pieces) > 1:
            i = rng.randrange(len(pieces) - 1)
            pieces[i:i + 2] = [tree_bpe.join_tokens(ranks, pieces[i], pieces[i + 1])]
        assert list(pieces[0]) == tree_bpe.merged(ranks, data)


def test_heap_and_scan_agree(words):
    for text in byte_runs(21, 300):
        data = text.encode()
        assert tree_bpe._merged_by_heap(words.ranks, [data[i:i + 1] for i in range(len(data))]) == tree_bpe.merged(words.ranks, data[:64]) or len(data) > 64
    for text in byte_runs(22, 60):
        data = (text * 3).encode()[:64]
        assert tree_bpe._merged_by_heap(words.ranks, [data[i:i + 1] for i in range(len(data))]) == tree_bpe.merged(words.ranks, data)


@pytest.mark.parametrize("text", ["a" * 100_000, "".join(random.Random(1).choices("abcdefghij", k=100_000)), "ab" * 50_000, "antidisestablishmentarianism" * 3600],
                         ids=["one letter", "random", "pairs", "one word"])
def test_runs_of_letters(words, text):
    """A match of 100,000 letters goes through all levels of the tree."""
    assert list(words.ids(text)) == tiktoken_of(words).encode_ordinary(text)


def test_encoded_equals_library(odd, table, documents, words):
    ranks, pattern = public_tokenizers.path(queries.BYTE_RANKS), public_tokenizers.PATTERN
    library = tiktoken_of(words)

    def row(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids

    out = got(tree_bpe.encoded(odd, ranks, pattern))
    assert sorted(out, key=repr) == sorted((row(*r) for r in ODD), key=repr)
    out = got(tree_bpe.encoded(documents, ranks, pattern, leaf=50))
    assert sorted(out) == sorted(row(r["doc_id"], r["text"]) for r in documents.collect())
    assert got(tree_bpe.encoded(table([]), ranks, pattern)) == []


# ---------------------------------------------------------------- token store

VOCABULARY = public_tokenizers.path(queries.WORD_VOCABULARY)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_encoder(library):
    encode = token_store.encoder(VOCABULARY, "<u2").encode
    texts = scraps(1, 3000) + [None, "", " "]
    ids, lengths = encode(pa.array(texts))
    parts = np.split(np.frombuffer(ids, "<u2"), np.cumsum(lengths)[:-1])
    for text, part in zip(texts, parts):
        assert part.tolist() == library(text)


@pytest.mark.parametrize("wide", [49_408, 70_000])
def test_store_round_trip(spark, table, documents, library, wide):
    rows = ODD + [tuple(r) for r in documents.select("doc_id", "text").collect()] + [(7, f"copy {i}") for i in range(30)] + [(None, "again")] * 20
    folder, keys = token_store.store(table(rows).repartition(5), VOCABULARY, wide)
    out = got(token_store.read(keys, folder, wide))
    assert len(out) == len(rows) == keys.count()
    out.sort(key=lambda r: r[2])
    start = 0
    for r in out:
        assert r[2] == start and r[3] == len(r[5]) and r[4] == zlib.crc32(np.array(r[5], "<u4").tobytes())
        start += r[3]
    ids = [(r[0] is not None, r[0] or 0) for r in out]
    assert ids == sorted(ids)
    assert sorted(((r[0], r[5]) for r in out), key=repr) == sorted(((i, library(t)) for i, t in rows), key=repr)
    copies = defaultdict(list)
    for r in out:
        copies[r[0]].append(r[1])
    assert all(c == list(range(len(c))) for c in copies.values())
    absent = spark.createDataFrame([(10**6 + i, 0) for i in range(500)] + [(4, 9), (4, 0)], "doc_id long, copy long")
    assert [r[:2] for r in got(token_store.find(absent, folder))] == [(4, 0)]


def test_store_empty(table):
    folder, keys = token_store.store(table([]), VOCABULARY, 49_408)
    assert got(keys) == [] and got(token_store.read(keys, folder, 49_408)) == []


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 200_000):
        hashes = token_store._mix(np.arange(n, dtype=np.uint64), 9)
        found = token_store.PerfectHash.build(hashes)
        assert np.array_equal(np.sort(found.slots(hashes)), np.arange(n))
        assert len(found.bits) * 64 <= max(6 * n, 64)


# ---------------------------------------------------------------- urls

URLS = [
    None, "", "http://", "no scheme", "http://net", "http://net/", "http://a.NET/x", "https://example.net/en", "https://example.net/en/1", "https://www.Example.net/en/?q=/fr/", "ftp://badexample.net/en/",
    "http://example.com/de/x", "http://m.example.com/DE/x", "http://example.com?/de/", "http://x.org#/fr/", "http://x.org/fr/#a", "http://org/fr/", "http://.org/fr/", "http://x.org/fr", "a://b://net/",
    "http://user@example.net:80/en/", "http://net./", "http://ÉX.net/", "HTTP://EXAMPLE.NET/en/\nx", "http://net/" + "a" * 50_000, "x" * 50_000,
]


def url_brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or (len(rule), len(own)) > (len(best[0]), best[0].index("/"))):
            best = (rule, verdict)
    return host, path, *(best or (None, "allow"))


def test_urls(spark):
    rnd = random.Random(8)
    hosts = [".".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    paths = ["/" + "".join(rnd.choice("xy/") for _ in range(rnd.randint(0, 4))) for _ in range(30)]
    rules = list({rnd.choice(hosts) + rnd.choice(paths): rnd.choice(["allow", "block"]) for _ in range(60)}.items())
    for chosen, urls in ((queries.URL_RULES, URLS), ([(v, r) for r, v in rules], [f"http://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(400)]), ([], URLS)):
        df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*urls, *urls])] + [(None, "http://net/", "x", "y")], "page_id long, url string, host string, verdict string")
        out = got(url_filter.filter_urls(df, chosen))
        want = [(i, *url_brute(u, chosen)) for i, u in enumerate([*urls, *urls])] + [(None, *url_brute("http://net/", chosen))]
        for a, b in zip(sorted(out, key=repr), sorted(want, key=repr)):
            assert a[:3] == b[:3] and a[3:] == b[3:]
    assert got(url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES)) == []


def test_digests_that_collide(tmp_path, monkeypatch):
    """Equal keys are told apart by their strings."""
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s) % 3)
    rules = [("block", f"{'a' * i}b/") for i in range(12)]
    (tmp_path / "rules").write_bytes(url_filter.pack(rules))
    stored = url_filter.DigestArray(str(tmp_path / "rules"))
    found = stored.find([r.encode() for _, r in rules] + [b"c/", b"ccccc/"])
    assert [stored.string(i).decode() for i in found[:12]] == [r for _, r in rules] and found[12:].tolist() == [-1, -1]


# ---------------------------------------------------------------- secrets

def base_brute(text):
    kinds = {
        "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m.group(2)) >= 8),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 16),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 32),
    }
    spans = [(m.start(), n, m.end(), kind) for n, (kind, (p, good)) in enumerate(kinds.items()) for m in p.finditer(text) if good(m)]
    return sorted(spans)


def linked_brute(text, base, reach=secret_scan.REACH):
    weak = []
    for n, (kind, (pattern, least)) in enumerate(secret_scan.WEAK.items(), 3):
        weak += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text, re.S) if len(m.group(1)) >= least and all(re.search(h, m.group(1)) for h in secret_scan.HOLDS.get(kind, []))]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    every = base + weak
    near = lambda w, kinds: any(e[3] in kinds and e[3] != w[3] and max(e[0], w[0]) <= (e[2] if e[0] <= w[0] else w[2]) + reach for e in every)
    return [w for w in weak if all(near(w, g) for g in secret_scan.NEEDS[w[3]])]


def secret_texts():
    rnd = random.Random(6)
    bits = ["password=hunter2hunter2", "token: 'short'", "token=secret:abcdefghij", "API_KEY = \"Zx9_kk-88.ab\"", "AKIA" + "Q7" * 8, "AKIAXY", "xAKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "f" * 40, "0123456789abcdef0",
            "Aa1" * 9, "https://db.example.org:443/x", "postgres://h/db", "user: bob_1", "client_id=42abc", "word", "größer", "😀", "\n", "x" * 150, "SECRET=ſecret", "apikey==========", "secret secret:  abcdefgh"]
    return [rnd.choice([" ", "", ", "]).join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(250)]


def test_secrets(table):
    rows = ODD + [(100 + i, t) for i, t in enumerate(secret_texts())] + [(400, ("password=hunter2hunter2 " + "lorem ipsum " * 40) * 60)]
    out = got(secret_scan.secrets(table(rows)))
    want, n_linked = [], 0
    for doc_id, text in rows:
        base = base_brute(text or "")
        weak = linked_brute(text or "", base)
        n_linked += len(weak)
        line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        count = lambda kind: sum(s[3] == kind for s in base)  # noqa: B023, E731
        want.append((doc_id, count("assign"), count("access"), count("hex"), hashlib.sha256(line(base).encode()).hexdigest(), line(base + weak), len(weak)))
    assert n_linked > 20
    for a, b in zip(sorted(out, key=repr), sorted(want, key=repr)):
        assert a == b
    assert got(secret_scan.secrets(table([]))) == []


# ---------------------------------------------------------------- language

def test_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b", "c"], 4, 3)
    x, y = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    x[5:, 0] = 256

    def loss():
        p, inside = language_id._positions(net, x), x != 256
        return -(np.log(p[:, y, np.arange(5)]) * inside).sum() / inside.sum()

    for w, grad in zip(net.weights, language_id.gradients(net, x, y)):
        for _ in range(10):
            at = tuple(int(rng.integers(0, s)) for s in w.shape)
            if w.shape[1] == 257 and at[1] == 256:
                continue
            old = w[at]
            w[at] = old + 1e-2
            up = loss()
            w[at] = old - 1e-2
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-2 - grad[at]) < 2e-3


@pytest.fixture(scope="module")
def net(spark):
    return language_id.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_language_held_out(spark, net):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r["doc_id"]: r for r in language_id.identify(docs, net).collect()}
    own = [(r["lang"], out[r["doc_id"]]) for r in docs.where("lang is not null").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for _, r in own)
    held = [(lang, r["lang_pred"]) for lang, r in own if r["held_out"]]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_language_odd(odd, table, net):
    out = {r["doc_id"]: r for r in language_id.identify(odd, net).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 11, 12)] == ["und"] * 5 and all(out[i]["lang_pred"] in net.languages for i in (4, 5, 8, 9, 10))
    assert abs(sum(out[9]["shares"].values()) - 1) < 1e-9 and out[1]["shares"] == {} and out[1]["score"] == 0
    assert language_id.identify(odd, net).count() == len(ODD)
    kept = language_id.keep_known(odd, net)
    assert kept.columns == odd.columns and {1, 2, 3, 11, 12}.isdisjoint(r["doc_id"] for r in kept.collect())
    nothing = language_id.fit(table([]))
    assert got(language_id.identify(table([]), nothing)) == []
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"} and language_id.keep_known(odd, nothing).count() == 0


def test_windows_do_not_depend_on_neighbours(net):
    texts = [b"short", "größer und länger ".encode() * 40, b"the end of the"]
    together = language_id.predict(net, texts)[0]
    for i, text in enumerate(texts):
        assert np.allclose(language_id.predict(net, [text])[0][0], together[i], atol=1e-5)


# ---------------------------------------------------------------- quality

def test_quality(spark, odd, table):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    rows = quality_rules.scored(docs, model).collect()
    # the compiled columns say what the rules say
    values = {n: np.array([r[n] for r in rows]) for n in quality_rules.STATISTICS}
    total = model.intercept + sum(rule.holds(values) * rule.weight for rule in model.rules)
    assert 3 < len(model.rules) < 150 and np.allclose([r["score"] for r in rows], 1 / (1 + np.exp(-total)))
    known = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect()}
    held = [(known[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in known]
    good, bad = ([s for q, s in held if q == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    out = quality_rules.scored(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert got(quality_rules.scored(table([]), model)) == []
    untaught = quality_rules.fit(docs, labels.where("false"))
    assert {r["score"] for r in quality_rules.scored(odd, untaught).collect()} == {0.5}
    twisted = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (10**9, 1, 1)], labels.schema))
    assert quality_rules.fit(docs.unionByName(docs), twisted).rules == model.rules


def test_statistics(table):
    texts = ["Ab, cd! 12\n\nx | $y", "", "É é\tÉ\r\nÉ é"]
    out = quality_rules.with_statistics(table(list(enumerate(texts))).select("doc_id", "text"), "text").collect()
    for r in out:
        text, words, lines = r["text"], re.findall("[^\x20\x09-\x0d]+", r["text"]), [x for x in re.split("[\r\n]+", r["text"]) if x]
        n = max(len(text), 1)
        blanks = sum(c in " \t\n\x0b\x0c\r" for c in text)
        assert r["upper_share"] == sum("A" <= c <= "Z" for c in text) / n and r["letter_share"] == sum("a" <= c <= "z" for c in text) / n
        assert r["blank_share"] == blanks / n and r["mean_word"] == (len(text) - blanks) / max(len(words), 1)
        assert r["distinct_words"] == len(set(words)) / max(len(words), 1) and r["distinct_lines"] == len(set(lines)) / max(len(lines), 1)
        assert r["symbol_share"] == sum(c in "|$" for c in text) / n and r["line_words"] == len(words) / max(len(lines), 1)


# ---------------------------------------------------------------- mixing

def spread_brute(children, budget):
    """children: {name: (capacity, weight)}; whole tokens by rising capacity/weight."""
    out, left, weight = {}, budget, sum(w for _, w in children.values())
    level = None
    for name, (capacity, w) in sorted(children.items(), key=lambda c: (c[1][0] / c[1][1], c[0] is not None, c[0] or "")):
        if level is None and capacity * weight <= w * left:
            out[name] = capacity
            left -= capacity
            weight -= w
        else:
            level = level or (left, weight)
            out[name] = w * level[0] // level[1]
    return out


def mix_brute(rows, share, weights, epochs):
    leaves = defaultdict(list)
    for doc_id, text, domain, lang, source in rows:
        n = len(re.findall("[^\x20\x09-\x0d]+", text or ""))
        if n:
            leaves[domain, lang, source].append((doc_id, n))
    tokens = {leaf: sum(n for _, n in own) for leaf, own in leaves.items()}
    budget = {(): int(sum(tokens.values()) * share)}
    for depth, level in enumerate(mixing.LEVELS):
        for parent in {leaf[:depth] for leaf in leaves}:
            children = {leaf[depth]: 0 for leaf in leaves if leaf[:depth] == parent}
            for name in children:
                children[name] = (epochs * sum(t for leaf, t in tokens.items() if leaf[:depth + 1] == (*parent, name)), weights.get(level, {}).get(name, 1))
            for name, given in spread_brute({n: c for n, c in children.items() if c[1] > 0}, budget.get(parent, 0)).items():
                budget[*parent, name] = given
    out = []
    for leaf, own in leaves.items():
        left, epoch = budget.get(leaf, 0), 0
        while left > 0:
            order = sorted(own, key=lambda d: (hashlib.md5(f"{mixing.SEED}:{epoch}:{'-' if d[0] is None else d[0]}".encode()).hexdigest(), d[1]))
            for doc_id, n in own if left >= tokens[leaf] else order:
                if left > 0:
                    out.append((doc_id, *leaf, epoch, n, min(n, left)))
                    left -= n
            epoch += 1
    return out


@pytest.mark.parametrize(("share", "epochs"), [(0.1, 1), (0.6, 1), (0.6, 3), (1.0, 1), (2.5, 3), (9.0, 2)])
def test_mix(spark, table, share, epochs):
    rnd = random.Random(int(share * 10) + epochs)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 40]) + "x", rnd.choice(["en", "en", "en", "de", None]), rnd.choice(["src0", "src0", "src1", "src2", None])) for i in range(300)]
    rows += [(1000 + i, t, "fr", "src3") for i, (_, t) in enumerate(ODD)]
    weights = {"domain": {"hub": 2, "odd": 3}, "lang": {"en": 5, "de": 1, "fr": 0}}
    frames = {level: spark.createDataFrame(list(w.items()), f"{level} string, weight long") for level, w in weights.items()}
    out = got(mixing.mix(table(rows), queries.domain(), share, frames, epochs))

    def domain(source):
        return "hub" if source == "src0" else "odd" if source and int(source[3:]) % 2 else "even"

    want = mix_brute([(i, t, domain(s), lang, s) for i, t, lang, s in rows], share, weights, epochs)
    assert sorted(out, key=repr) == sorted(want, key=repr)
    assert got(mixing.mix(table([]), queries.domain(), share, frames, epochs)) == []
