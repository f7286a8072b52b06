import re

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm import secret_scan
from test_training_operators import classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def through(spark, docs, tmp_path):
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs)
    return counts


def test_stages_take_effect(spark, tmp_path):
    base = " ".join(f"word{k % 97} thing{k}" for k in range(120))
    rows = [(1, base, "en"), (2, base + " ", "en"), (3, base.replace("thing7 ", "other "), "en"), (4, "1234 ... 5678", "en"), (5, None, None), (6, "quite another text that says token = 'abcdefgh12345' and more", "en"), (7, "", None)]
    docs = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows], SCHEMA)
    language, exact, near, secrets, packed = through(spark, docs, tmp_path)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").distinct().collect())
    assert ids(language) == [1, 2, 3, 6] and ids(exact) == [2, 3, 6] and ids(near) == [2, 6] and ids(secrets) == [2, 6] and ids(packed) == [2, 6]
    six = secrets.where("doc_id = 6").first()
    assert "[secret]" in six.text and "abcdefgh" not in six.text and six.n_chars == len(six.text)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "a", None, None, 1)] * 3])
def test_odd_tables(spark, tmp_path, rows):
    through(spark, spark.createDataFrame(rows, SCHEMA), tmp_path)


def test_stages_by_brute_force(spark, sf_dir, tmp_path):
    """Every document of the smallest table, with copies, rows without an id and texts without letters, by plain Python."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    some = rows[:40]
    rows += [(10_000 + k, t.replace(" ", "  ", 3), *rest) for k, (_, t, *rest) in enumerate(some)] + [(20_000 + k, t + " one more", *rest) for k, (_, t, *rest) in enumerate(some)]
    rows += [(30_000, "12 34 ... 56", "en", "s", 12), (30_001, None, None, None, None), (30_002, 'with token = "abcdefgh1" in it', "en", "s", 30), (30_003, "with AKIA" + "B" * 16 + " in it", "en", "s", 34)]
    language, exact, near, secrets, packed = through(spark, spark.createDataFrame(rows, SCHEMA), tmp_path)
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    want = {k: t for k, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert texts(language) == want
    best = {}
    for k, t in want.items():
        key = re.sub("[ \t\n\x0b\f\r]", "", t)
        best[key] = min(best.get(key, (1,)), (-len(t), k))
    want = {k: want[k] for _, k in best.values()}
    assert texts(exact) == want
    ids = sorted(want)
    want = {ids[c]: want[ids[c]] for c in classes([want[k] for k in ids])}
    assert texts(near) == want

    def redacted(text):
        spans = sorted((m.start(), m.end()) for kind in (*secret_scan.BASE, *secret_scan.ADDED) for m in re.finditer(kind.pattern, text) if len(m[kind.group]) >= kind.least)
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += text[at:s] + "[secret]"
            at = max(at, e)
        return out + text[at:]

    want = {k: redacted(t) for k, t in want.items()}
    assert texts(secrets) == want and sum("[secret]" in t for t in want.values()) >= 2
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {k: [i for _, ids in sorted(p) for i in ids] for k, p in pieces.items()} == {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in want.items()}


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "ids", "sequence_id", "offset"} <= set(out.columns)
