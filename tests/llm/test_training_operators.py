"""The ten operators against brute force, exact round trips and odd input."""

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import bpe, chat, exact, langid, near, omh, packing, queries, repair, secret_scan, warc, words

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, class_id string, kept string"
ODD = ["", " ", "\n", "a", "a  b", "foo.\n  Bar", "x\t\ty", "\x1cfoo \x1d", "\x00a", "<|endoftext|>", "a <|endoftext|>b <|startoftext|> c", "é" * 50, "日本語 テスト", "aaaa" * 30, "😀 😀", "it's we'll 'S", "\r\n\r\n a", "a   ", "K K", "é x", "ΑΣ", '"a", b... c,. d', "a\x85b"]


def noise(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(" \n\tab'sé1.,<|>́\x1c日") for _ in range(r.randint(0, 40))) for _ in range(n)]


def documents(spark, texts):
    """Rows with clashing extra columns."""
    return spark.createDataFrame([(k, t, None, None, None if t is None else len(t), "x", "y", "z") for k, t in texts], DOCS)


EDGE = [(1, None), (2, ""), (None, "null id"), (4, "same text here for all of us today"), (5, "same text here for all of us today"), (4, "same text here for all of us today"), (7, "long words " * 20000), (8, "..."), (-9, "tie\x20tie"), (10, "tie tie ")]


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, EDGE).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_bpe_is_the_librarys(spark):
    library, own = Tokenizer.from_file(BYTE), bpe.PairIndexBpe(BYTE)
    texts = ODD + noise(1500)
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_operators(spark, edge, empty):
    rows = bpe.round_trip(edge).collect()
    assert len(rows) == len(EDGE) and all(r.same for r in rows)
    library = Tokenizer.from_file(BYTE)
    for r in rows:
        text = next(t or "" for k, t in EDGE if k == r.doc_id)
        assert r.ids_sha256 == hashlib.sha256(np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode(bpe.encode(edge))
    assert collected(back, "doc_id", "text") == sorted(((k, t or "") for k, t in EDGE), key=repr)
    assert bpe.round_trip(empty).count() == 0


def test_stretches_are_the_librarys():
    library, own = Tokenizer.from_file(WORD), words.StretchEncoder(WORD)
    texts = ODD + noise(3000, 2)
    for part in itertools.batched(texts, 64):
        ids, n = own.encode_batch(list(part), 2)
        for t, got in zip(part, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert got.tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t


def test_full_caches_change_nothing(monkeypatch):
    """A cache that is full all the time, by its stretches or by their characters, keeps what was met again."""
    library = Tokenizer.from_file(WORD)
    texts = [f"{t} again and again" for t in ODD + noise(300, 5)] + ["z" * 900, "and " * 40]
    for name, limit in (("CACHE_STRETCHES", 40), ("CACHE_CHARS", 60)):
        own = words.StretchEncoder(WORD)
        monkeypatch.setattr(words, name, limit)
        for part in itertools.batched(texts * 2, 8):
            ids, n = own.encode_batch(list(part))
            for t, got in zip(part, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                assert got.tolist() == library.encode(t, add_special_tokens=False).ids, t
        own.shrink()
        assert "again" in own.known and "z" * 900 not in own.known and len(own.known) < 200
        monkeypatch.undo()


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in text).split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts):
    """Brute force: weighted Jaccard by exact document frequencies, all pairs, then connected parts."""
    bags = [shingles(t) for t in texts]
    df = Counter(s for b in bags for s in b)
    weighted = [{s: n * (1 + near.SPREAD * math.log1p(len(texts) / df[s]) / math.log1p(len(texts))) for s, n in b.items()} for b in bags]
    holders = defaultdict(list)
    for k, b in enumerate(bags):
        for s in b:
            holders[s].append(k)
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in {p for h in holders.values() for p in itertools.combinations(h, 2)}:
        x, y = weighted[a], weighted[b]
        common = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
        if common / (sum(x.values()) + sum(y.values()) - common) >= 0.8 or texts[a] == texts[b]:
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return [root(k) for k in range(len(texts))]


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(7)
    vocabulary = ["w%d" % k for k in range(3000)]
    texts = []
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 200))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 8)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["", "", "...", "one two", "one two", "One, two!"]
    out = near.near_duplicates(documents(spark, list(enumerate(texts))))
    got = {x.doc_id: x.class_id for x in out.collect()}
    want = classes(texts)
    # Texts without words are alike only if equal.
    assert [got[k] for k in range(len(texts))] == [texts.index(t) if not shingles(t) else c for t, c in zip(texts, want, strict=True)]


def test_near_large_group(spark):
    """Hundreds of copies of one base, each with an edit of its own, in buckets that aren't paired in full."""
    r = random.Random(3)
    base = ["v%d" % k for k in range(150)]
    texts = [" ".join([*base[:k], f"edit{i}", *base[k + 1 :]]) for i, k in enumerate(r.choices(range(150), k=300))]
    got = near.near_duplicates(documents(spark, list(enumerate(texts)))).collect()
    assert {x.class_id for x in got} == {0}


def test_near_pairs_behind_a_template(spark):
    """Pairs of alike texts among hundreds that share a template, so that their buckets hold many other classes."""
    template = " ".join("t%d" % k for k in range(204))
    family = [" ".join(f"f{f}x{k}" for k in range(8)) for f in range(250)]
    own = [" ".join(f"o{i}x{k}" for k in range(19)) for i in range(500)]
    got = near.near_duplicates(documents(spark, [(i, f"{family[i % 250]} {template} {own[i]}") for i in range(500)])).collect()
    assert {x.doc_id: x.class_id for x in got} == {i: i % 250 for i in range(500)}


def test_near_partners_in_a_large_class(spark):
    """Texts alike to one member each of a large class, and to no other."""
    base = " ".join("b%d" % k for k in range(204))
    member = [f"{base} m{i}" for i in range(800)]
    apart = [f"{member[i]} " + " ".join(f"s{i}x{k}" for k in range(41)) for i in range(0, 800, 4)]
    got = near.near_duplicates(documents(spark, list(enumerate(member + apart)))).collect()
    assert {x.class_id for x in got} == {0}


def test_near_recall_at_the_threshold(spark):
    """Of pairs whose own similarity is just over 0.8, measured by hand, at least 99 in 100 are linked; of those just under it, none."""
    r = random.Random(13)
    texts, near_pairs, apart = [], [], []
    for k in range(700):
        base = [f"p{k}x{r.randrange(4000)}" for _ in range(240)]
        other = list(base)
        for at in r.sample(range(0, 236, 6), 5 if k % 2 else 6):
            other[at] = f"q{k}y{at}"
        texts += [" ".join(base), " ".join(other)]
    bags = [shingles(t) for t in texts]
    df = Counter(s for b in bags for s in b)
    weight = lambda s, n: n * (1 + near.SPREAD * math.log1p(len(texts) / df[s]) / math.log1p(len(texts)))
    for k in range(0, len(texts), 2):
        x, y = ({s: weight(s, n) for s, n in b.items()} for b in bags[k : k + 2])
        common = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
        (near_pairs if common / (sum(x.values()) + sum(y.values()) - common) >= 0.8 else apart).append(k)
    got = {x.doc_id: x.class_id for x in near.near_duplicates(documents(spark, list(enumerate(texts)))).collect()}
    found = sum(got[k] == got[k + 1] for k in near_pairs)
    assert len(near_pairs) > 300 and len(apart) > 300 and found >= 0.99 * len(near_pairs), (found, len(near_pairs), len(apart))
    assert not any(got[k] == got[k + 1] for k in apart)


def test_near_edges(spark, edge, empty):
    got = {(x.doc_id, x.text_id): x.class_id for x in near.near_duplicates(edge).collect()}
    assert got[(4, 4)] == got[(5, 4)] == 4 and got[(1, 1)] == got[(2, 1)] == 1 and got[(None, None)] is None and got[(-9, -9)] == got[(10, -9 if (10, -9) in got else 10)]
    assert near.near_duplicates(empty).count() == 0


def test_weighted_sampling_estimates():
    r = np.random.default_rng(5)
    a = np.sort(r.choice(1 << 52, 4000, replace=False).astype(np.uint64))
    weights = r.uniform(0.5, 8, 4000)
    one, two = a[:3500], a[500:]
    same = near.signatures(np.concatenate((one, two)), np.concatenate((weights[:3500], weights[500:])), np.array([0, 3500, 7000]))
    want = near.weighted_jaccard((one, weights[:3500]), (two, weights[500:]))
    assert abs((same[0] == same[1]).mean() - want) < 0.12 and abs(want - 0.75) < 0.03


def test_components(spark):
    r = random.Random(11)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    up = {}

    def root(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    linked = {x for e in edges for x in e if e[0] != e[1]}
    got = {x.id: x["class"] for x in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for k in linked}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(version):
    head = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n"
    raw = warc.arc_bytes([(b"http://a/x%20y", b"1.2.3.4", b"19970214093001", b"text/html", head + b"a\n\n"), (b"dns:a", b"-", b"1997", b"text/dns", b"x\nhttp://b 1 2 3 4\n"), (b"http://e", b"-", b"19970214093001", b"text/html", b"")], version, "t.arc")
    records = list(warc.arc_records(raw))
    assert [(r.version, r.url, r.mime, r.block) for r in records] == [(version, b"http://a/x%20y", b"text/html", head + b"a\n\n"), (version, b"dns:a", b"text/dns", b"x\nhttp://b 1 2 3 4\n"), (version, b"http://e", b"text/html", b"")]
    made = b"".join(warc.convert_record("t.arc", r, None) for r in records)
    read = list(warc.warc_records(made))
    assert [(f["WARC-Type"], f["WARC-Date"]) for f, _ in read] == [("response", "1997-02-14T09:30:01Z"), ("resource", "1997-01-01T00:00:00Z"), ("resource", "1997-02-14T09:30:01Z")]
    assert read[0][0]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"a\n\n").digest()).decode() and len({f["WARC-Record-ID"] for f, _ in read}) == 3
    cut = list(warc.arc_records(raw[: raw.index(b"x\nhttp://b") + 5]))
    assert [r.truncated for r in cut] == [False, True] and b"WARC-Truncated: length" in warc.convert_record("t.arc", cut[1], None)
    for bad in (b"nonsense\n", raw.replace(b"filedesc", b"filedesk", 1), raw + b"x y\n"):
        with pytest.raises(ValueError):
            list(warc.arc_records(bad))


def test_warc_query(spark, empty):
    schema = "page_id long, url string, html string, digest string, source string"
    big = "x" * 5_000_000
    pages = [(3, "http://a b", "same"), (1, None, "same"), (7, "u", None), (9, "u", ""), (2, "é", "é\r\n\r\n"), (8, "u", big), (6, "u", big), (6, "u", big), (None, "u", "n"), (None, "u", "n"), (None, "u", "same")]
    out = warc.read_warcs(warc.convert(warc.write_arcs(spark.createDataFrame([(*p, "d", "s") for p in pages], schema))))
    got = collected(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    least = {}
    for k, _, h in pages:
        if k is not None:
            least[h or ""] = min(least.get(h or "", k), k)
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = [least.get(h or "") for _, _, h in pages]
    want = [(k, len((h or "").encode()), sha(h), "response" if f == k else "revisit", None if f == k else f) for (k, _, h), f in zip(pages, first, strict=True)]
    assert got == sorted(want, key=repr)
    assert warc.read_warcs(warc.convert(warc.write_arcs(spark.createDataFrame([], schema)))).count() == 0


def test_language_id(spark, sf_dir, edge, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.join(langid.identify(docs.select("doc_id", "text"), langid.train(docs)).drop("text"), "doc_id").withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    assert all(r.held == langid.crc32_fold(r.doc_id) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9
    model = langid.train(docs)
    got = {r.doc_id: r.lang_pred for r in langid.identify(edge, model).collect()}
    assert got[1] == got[2] == got[8] == "und" and got[4] != "und"
    assert langid.identify(edge, langid.train(empty)).where("lang_pred != 'und' or score != 0").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_naive_bayes_by_brute_force():
    counts = np.random.default_rng(1).integers(0, 50, (1 << langid.BITS, 2)).astype(float)
    model = langid.Model(["a", "b"], counts, np.array([3.0, 5.0]))
    for text in ("Hällo wörld 42", "x", "ab cd ab"):
        index, starts = langid.features([text])
        by_hand = model.prior + sum(np.log((counts[i] + langid.SMOOTHING) / (counts + langid.SMOOTHING).sum(0)) for i in index)
        assert model.predict([text])[0] == [model.languages[int(np.argmax(by_hand))]]
        plain = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        padded = " " + " ".join(plain) + " "
        assert len(index) == sum(not (n == 1 and padded[i] == " ") for n in range(1, 5) for i in range(len(padded) - n + 1))


@pytest.mark.parametrize("seed", range(6))
def test_repair_round_trip(seed):
    r = np.random.default_rng(seed)
    counts = r.integers(0, 400, 60)
    ids = (r.zipf(1.3, counts.sum()) % (12 if seed % 2 else 5000)).astype(np.uint32)
    names = [None if k == 3 else k - 5 for k in range(60)]
    blob = repair.write_shard(names, counts, ids, 5000)
    shard = repair.Shard(blob)
    assert shard.doc_ids == names and shard.all_ids().tolist() == ids.tolist()
    ends = np.cumsum(counts)
    for k in range(60):
        doc = ids[ends[k] - counts[k] : ends[k]].tolist()
        assert shard.document(k).tolist() == doc
        a, b = sorted(r.integers(0, counts[k] + 1, 2).tolist())
        assert shard.document(k, a, b).tolist() == doc[a:b]
    if seed % 2:
        assert len(shard.symbols) < 0.8 * len(ids)


def test_grammar_leaves_no_frequent_pair(monkeypatch):
    """Pairs that can't overlap share a turn: far fewer turns than rules, and still no pair occurs so often in the end."""
    r = np.random.default_rng(3)
    counts = r.integers(1, 300, 400)
    ids = (r.zipf(1.2, counts.sum()) % 900).astype(np.uint32)
    turns, grouped = [], repair.groups
    monkeypatch.setattr(repair, "groups", lambda *a: turns.append(1) or grouped(*a))
    symbols, per, rules, lengths = repair.grammar(ids, counts, 900, 8)
    assert len(rules) > 300 and len(turns) < len(rules) / 2
    left = Counter()
    for doc in np.split(symbols, np.cumsum(per)[:-1]):
        before = None
        for pair in itertools.pairwise(doc.tolist()):
            before = None if pair == before else pair  # of a run every second place
            left[pair] += before is not None
    assert max(left.values()) < 8


def test_shards_end_where_they_are_full(spark, tmp_path):
    docs = spark.createDataFrame([(k, "one two three four") for k in range(50)], "doc_id long, text string")
    repair.write_token_files(docs, str(tmp_path / "files"), shard_ids=20, partitions=1)
    shards = spark.read.parquet(str(tmp_path / "files")).orderBy("shard").collect()
    assert [x.n_ids for x in shards] == [20] * 12 + [10] and [x.before for x in shards] == list(range(0, 250, 20))


def test_token_files(spark, edge, empty, tmp_path):
    library = Tokenizer.from_file(WORD)
    for name, shard_ids in (("one", 1 << 20), ("many", 8)):
        path = str(tmp_path / name)
        repair.write_token_files(edge, path, shard_ids=shard_ids, partitions=3)
        got = sorted(repair.read_token_files(spark, path).collect(), key=lambda r: r.start)
        order = sorted(EDGE, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
        at = 0
        for r, (k, t) in zip(got, order, strict=True):
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
    repair.write_token_files(empty, str(tmp_path / "none"))
    assert repair.read_token_files(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(("tokens", "segments", "loss"), [(2048, 64, 2048), (64, 3, 40), (16, 1, 5)])
def test_packing(spark, sf_dir, edge, tokens, segments, loss):
    library = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").select("doc_id", "text").withColumn("prompt", F.when(F.col("doc_id") % 2 == 0, 7))
    rows = packing.pack(docs, prompt_col="prompt", tokens=tokens, segments=segments, loss=loss).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d in docs.collect():
        pieces = sorted(by_doc[d.doc_id], key=lambda r: r.start)
        ids = [*library.encode(d.text, add_special_tokens=False).ids, 1]
        assert [i for p in pieces for i in p.ids] == ids and all(p.doc_tokens == len(ids) and p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces)
        assert [p.start for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces[:-1])]
        assert sum(p.loss_tokens for p in pieces) == max(0, len(ids) - (d.prompt or 0))
    padding = 0
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        n = sum(r.length for r in s)
        assert n <= tokens and len(s) <= segments and sum(r.loss_tokens for r in s) <= loss
        assert [r.offset for r in s] == [0, *itertools.accumulate(r.length for r in s[:-1])]
        padding += tokens - n if n & (n - 1) else 0
    if tokens == 2048:
        assert padding < 0.01 * sum(r.length for r in rows)


def test_packing_edges(spark, edge, empty):
    rows = packing.pack(edge).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1 and packing.pack(empty).count() == 0
    assert {r.doc_id for r in rows} == {k for k, _ in EDGE}


SECRETS = ["", 'token = "abcdefgh"', "token=passwd:'abcdefghij'", "PASSWORD: short api_key=" + "x" * 9, "AKIA" + "A" * 12 + " AKIA1", "0" * 31 + " " + "f" * 32, "é token='" + "0123456789abcdef" * 2 + "'", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "tokentoken=aaaaaaaaa", "secret:\x20\x20=abcdefgh", "apikey='AKIA" + "B" * 14]


def by_regex(text, kinds):
    import re

    out = []
    for rank, k in enumerate(kinds):
        for m in re.finditer(k.pattern, text):
            if len(m[k.group]) >= k.least:
                out.append((m.start(), rank, k.name, m.end()))
    return ",".join(f"{n}:{s}:{e}" for s, _, n, e in sorted(out))


def test_secret_scan_by_regex(spark, edge):
    r = random.Random(2)
    #: The base kinds as the contract words them.
    plain = (secret_scan.BASE[0], secret_scan.Kind("access", "AKIA[A-Z0-9]+", 0, 16), secret_scan.Kind("hex", "[0-9a-f]+", 0, 32))
    texts = SECRETS + ["".join(r.choice(["token", "=", ":", '"', " ", "AKIA", "0a1b" * 8, "xyz", "é", "\n", "Password", "api_key", "ABCDEFGH", "AKI"]) for _ in range(30)) for _ in range(300)]
    got = {x.doc_id: x for x in secret_scan.scan_documents(documents(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        assert got[k].base == by_regex(t, plain) and got[k].spans == by_regex(t, (*plain, *secret_scan.ADDED)), t
    assert secret_scan.scan_documents(edge).where("spans != ''").count() == 0 and secret_scan.scan_documents(edge).count() == len(EDGE)


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    book = secret_scan.BlobLedger(spark, path)
    first = documents(spark, [(1, 'token="abcdefgh1"'), (2, 'token="abcdefgh1"'), (3, "clean"), (None, "clean")])
    book.update(first)
    assert book.scanned().count() == 2 and book.findings().count() == 1
    book.update(first)
    assert book.scanned().count() == 2
    second = documents(spark, [(1, "clean now"), (4, 'token="abcdefgh1"'), (5, "AKIA" + "C" * 16)])
    book.update(second)
    assert book.scanned().count() == 4 and book.findings().count() == 2
    assert collected(book.report(second), "doc_id", "spans") == [(1, ""), (4, "assign:0:16"), (5, "access:0:20")]
    book.update(second, rules="base-2")
    assert book.scanned().where("rules = 'base-2'").count() == 3


def test_redaction(spark):
    docs = documents(spark, [(1, 'a token="abcdefgh1" b ' + "f" * 32), (2, None), (3, "x")])
    assert collected(secret_scan.redact(docs), "doc_id", "text") == [(1, 'a [secret]" b [secret]'), (2, None), (3, "x")]


def test_exact_dedup(spark, edge, empty):
    r = random.Random(4)
    rows = [(k, r.choice(["hot text", "hot  text ", " hottext"])) for k in range(300)] + [(1000 + k, f"t{k % 50}" + " " * r.randint(0, 3)) for k in range(200)] + EDGE[:4]
    for hot, counters in ((1 / 256, 1024), (0.1, 12)):
        got = exact.resolve(documents(spark, rows), hot=hot, counters=counters).collect()
        groups = defaultdict(list)
        for k, t in rows:
            groups[exact.normalised((t or "").encode())].append((-len(t or ""), k is None, k or 0, k))
        want = sorted(((k, min(g)[3], len(g), k == min(g)[3], hashlib.sha256(n).hexdigest()) for n, g in groups.items() for *_, k in g), key=repr)
        assert sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got), key=repr) == want
    assert exact.resolve(empty).count() == 0 and exact.deduplicate(empty).count() == 0
    kept = exact.deduplicate(edge)
    # 1 and 2 are empty, 4 and 5 equal, and of -9 and 10 the latter has more code points.
    assert kept.columns == edge.columns and {k for (k,) in collected(kept, "doc_id")} == {1, 4, 7, 8, 10, None} and kept.count() == 6


def test_exact_dedup_of_missing_and_repeated_ids(spark):
    """One row of each text stays, whatever its id."""
    rows = [(None, f"text {k}") for k in range(50)] * 2 + [(None, None), (None, " \t\n\x0b\f\r"), (7, "one"), (7, "two"), (7, "t wo"), (7, "two"), (0, "zero"), (None, "no id"), (8, "no id"), (None, "é\u00a0x")]
    got = exact.deduplicate(documents(spark, rows)).collect()
    best = {}
    for k, t in rows:
        key = exact.normalised((t or "").encode())
        best[key] = min(best.get(key, (1,)), (-len(t or ""), k is None, k or 0, t or ""))
    assert sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in got) == sorted(b[1:] for b in best.values())


def test_misra_gries():
    r = random.Random(6)
    keys = [r.choice("aaaabbc" + "".join(map(chr, range(200, 300)))).encode() for _ in range(5000)]
    m = exact.MisraGries(20)
    m.add(keys)
    true = Counter(keys)
    assert all(true[k] - len(keys) / 21 <= m.counts.get(k, 0) <= true[k] for k in true) and len(m.counts) <= 20


def test_chat(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, formatted string, ids string"
    said = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", "hi <\\| <| there"), (1, 1, "assistant", "\n\n héllo 😀"), (1, 2, "assistant", ""), (1, 3, "user", None), (1, 4, "assistant", said), (2, 0, None, "x"), (None, 0, "assistant", "y"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, None, "user", "first")]
    turns += [(5, k, "assistant" if k % 2 else "user", f"turn {k} <|im_sep|> é") for k in range(200)]
    df = spark.createDataFrame([(*t, "f", "i") for t in turns], schema)
    for size in (1 << 20, 50):
        formatted = chat.format_conversations(df, segment_chars=size)
        got = {r.conv_id: r for r in chat.digests(formatted).collect()}
        by = defaultdict(list)
        for c, t, role, text in turns:
            by[c].append(((t is not None, t or 0), role or "", text or ""))
        assert set(got) == set(by)
        for c, rows in by.items():
            rows.sort()
            loss = "".join(x for _, role, x in rows if role == "assistant")
            assert got[c].n_turns == len(rows) and got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in rows).encode()).hexdigest()
            assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
            assert got[c].formatted_chars == len(chat.render([(role, x) for _, role, x in rows], frozenset())[0])
    library, whole = chat.ChatEncoder(BYTE).library, {}
    for r in chat.format_conversations(df).collect():
        got = library.encode(r.formatted, add_special_tokens=False)
        starts = np.cumsum(r.steps)
        assert r.segment == 0 and r.last and r.ids == got.ids and list(zip(starts.tolist(), (starts + r.widths).tolist(), strict=True)) == got.offsets
        whole[r.conv_id] = r.formatted, r.ids
    cut = defaultdict(list)
    for r in sorted(chat.format_conversations(df, segment_chars=50).collect(), key=lambda r: r.segment):
        cut[r.conv_id].append(r)
    assert {c: ("".join(r.formatted for r in rows), [i for r in rows for i in r.ids]) for c, rows in cut.items()} == whole
    assert len(cut[5]) > 10 and all([r.last for r in rows] == [False] * (len(rows) - 1) + [True] for rows in cut.values())
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0
    for t in noise(200) + ["<|", "<\\|", "<\\\\|im_end|>", said]:
        assert chat.unescape(chat.escape(t)) == t and chat.START not in chat.escape(t) and chat.END not in chat.escape(t)


def by_hand(text):
    hashes = omh.kmer_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32)).tolist()
    seen, bins = Counter(), [[] for _ in range(omh.SKETCHES)]
    for i, h in enumerate(hashes):
        v = h if not seen[h] else int(omh.mix(np.array([(h + seen[h] * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
        seen[h] += 1
        bins[v >> 58].append((v, i))
    out = [0] * omh.SKETCHES
    for k, b in enumerate(bins):
        if b:
            pick = sorted(sorted(b)[: omh.TUPLE], key=lambda x: x[1])
            rest = 1 if len(pick) == 1 else int(omh.mix(np.array([pick[1][0] ^ 0x5851F42D4C957F2D], np.uint64))[0])
            out[k] = int(omh.mix(np.array([(pick[0][0] + rest) % 2**64], np.uint64))[0])
    for k, b in enumerate(bins):
        if not b and hashes:
            out[k] = out[next(d for d in omh.DRAWS[k] if bins[d])]
    return [x >> 32 for x in out]


def test_fingerprints():
    r = random.Random(9)
    texts = ["", "a", "short", "x" * 500, "abc " * 300, *["".join(r.choice("abcdefgh é") for _ in range(r.randint(12, 4000))) for _ in range(40)]]
    for t in texts:
        assert omh.fingerprint(t).tolist() == by_hand(t)
    text = "".join(r.choice("abcdefghijklmnop ") for _ in range(4000))
    swapped = text[2000:] + text[:2000]
    edits = [omh.likeness(omh.fingerprint(text), omh.fingerprint(text[: 4000 - n] + swapped[:n])) for n in (0, 100, 800, 4000)]
    assert edits[0] == 1 and edits[1] > 0.7 and edits[1] > edits[2] and edits[3] < 0.7


def test_next_documents(spark, empty):
    texts = [(5, "five " * 30), (-2, ""), (9, None), (7, "sieben" * 9), (12, "z"), (7, "aaa" * 40), (None, "nothing"), (30, "thirty " * 50)]
    for partitions in (1, 3, 8):
        got = omh.compare_with_next(documents(spark, texts), partitions=partitions).collect()
        order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
        want = []
        for (k, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
            t, after = t or "", after or ""
            new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            a, b, c = map(omh.fingerprint, (t, new, after))
            want.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(), omh.packed(a).hex(), omh.packed(b).hex(), omh.likeness(a, b), omh.likeness(a, c)))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    one = omh.compare_with_next(documents(spark, [(1, "abcd")])).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, hashlib.sha256(b"abab").hexdigest())]
    assert omh.compare_with_next(empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in got.description]
    own = queries.QUERIES[name](spark, sf_dir)
    assert sorted(own.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, own.select(columns).collect()))) == sorted(map(repr, got.fetchall()))
